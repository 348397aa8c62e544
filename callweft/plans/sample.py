"""A small workspace of source and metadata files for the code queries and the tests."""

FILES = {
    "/w/src/classes/Billing.cls": """// Billing: charge(x) in a comment
public with sharing class Billing {
    public void charge(Id acct, Decimal amount) { }
    public static void audit() { }
}""",
    "/w/src/classes/InvoiceHandler.cls": """public class InvoiceHandler {
    private Billing field;
    public void run() {
        Billing b = new Billing();
        b.charge(acctId, 10.5);
        Billing.audit();
        this.step('a, (b)');
    }
    public void step(String s) { field.charge(s, 1); }
}""",
    "/w/src/triggers/InvoiceTrigger.trigger": "trigger InvoiceTrigger on Invoice__c (after insert) { new InvoiceHandler().run(); }",
    "/w/src/classes/Shape.cls": "public interface Shape { Decimal area(); }",
    "/w/src/classes/Square.cls": "public virtual class Square implements Shape { public virtual Decimal area() { return side(); } protected Decimal side() { return 2; } }",
    "/w/src/classes/BigSquare.cls": "public class BigSquare extends Square { public override Decimal area() { return super.area() * side(); } }",
    "/w/src/classes/Drawing.cls": """public class Drawing {
    public static Drawing make() { return new Drawing(); }
    public Drawing add(Shape s) { s.area(); return this; }
    public void show() { Drawing.make().add(new Square()).show(); }
    public void guess(Object o) { if (o instanceof Square) { o.side(); } mystery.onlyHere(1); }
    public class Part { public void touch() { Drawing.make(); } }
}""",
    "/w/src/classes/Lonely.cls": "public class Lonely { public void onlyHere(Integer n) { ext.Gateway.ping(n); nothing.atAll(); } }",
    "/w/src/classes/Saver.cls": """public class Saver {
    @AuraEnabled
    public static void save() {
        Invoice__c inv = new Invoice__c();
        insert inv;
        update inv;
        List<Invoice__c> many = new List<Invoice__c>();
        Database.insert(many);
        System.enqueueJob(new Job());
        EventBus.publish(new Done__e());
        String name = 'Lonely';
        Type t = Type.forName(name);
        throw new SaverException('no');
    }
    @InvocableMethod(label='Save')
    public static void fromFlow() { save(); }
}""",
    "/w/src/classes/SaverException.cls": "public class SaverException extends Exception { }",
    "/w/src/classes/Job.cls": "public class Job implements Queueable { public void execute(QueueableContext c) { } }",
    "/w/src/triggers/DoneTrigger.trigger": "trigger DoneTrigger on Done__e (after insert) { Saver.save(); }",
    "/w/src/classes/SaverTest.cls": "@isTest private class SaverTest { @isTest static void works() { Saver.save(); } }",
    "/w/src/classes/Account2.cls": """public class Account2 {
    public Integer total { get { return count(); } set { audit(value); } }
    public String plain { get; set; }
    private Integer count() { return 1; }
    private void audit(Integer v) { }
    public static void use(Account2 a) { a.total = 3; Integer t = a.total; a.plain = 'x'; }
}""",
    "/w/src/lwc/panel/panel.js": "import save from '@salesforce/apex/Saver.save';",
    "/w/src/aura/Box/Box.cmp": '<aura:component controller="Saver"></aura:component>',
    "/w/src/aura/Box/BoxController.js": "({ go: function(cmp) { cmp.get('c.save'); } })",
    "/w/src/flows/Nightly.flow-meta.xml": "<Flow><start><object>Invoice__c</object><recordTriggerType>Create</recordTriggerType><triggerType>RecordAfterSave</triggerType></start><actionCalls><actionName>Saver</actionName><actionType>apex</actionType></actionCalls><subflows><name>s</name><flowName>Child</flowName></subflows></Flow>",
    "/w/src/flows/Child.flow-meta.xml": "<Flow><actionCalls><actionName>ns__Thing</actionName><actionType>apex</actionType></actionCalls></Flow>",
    "/w/src/omni/Pay.os-meta.xml": "<O><remoteClass>Billing</remoteClass><x/><remoteMethod>charge</remoteMethod></O>",
    "/w/src/pages/Pay.page": '<apex:page controller="Billing" extensions="Drawing, Saver"><apex:commandButton action="{!save}"/></apex:page>',
    "/w/src/customMetadata/Map.One.md-meta.xml": "<CustomMetadata><values><field>Handler__c</field><value xsi:type='x'>InvoiceHandler</value></values><values><field>Note__c</field><value>two words</value></values></CustomMetadata>",
    "/w/node_modules/x/Skip.cls": "public class Skip { }",
}


def frame(spark, files=None):
    return spark.createDataFrame(list((files or FILES).items()), "path string, text string")
